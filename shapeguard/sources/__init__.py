"""Where tables of strings come from and go to."""

"""DataFrame to DataFrame operators. They plan; only where stated do they collect, and then a bounded number of rows."""

"""Column expressions: text, named formats, masks and folds. Nothing here runs a job."""

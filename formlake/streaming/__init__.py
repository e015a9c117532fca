"""File streams that run the batch code on what has newly arrived."""

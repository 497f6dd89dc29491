"""Training-data operators: each module has one operator and its opN_ query."""

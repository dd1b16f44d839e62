"""What a query is made of before it becomes a DataFrame: the model, predicates and order keys."""

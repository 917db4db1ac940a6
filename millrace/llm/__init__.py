"""Training-data operators: ten large-scale corpus operations and their registered queries."""

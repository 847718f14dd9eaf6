"""Training-data operators: ten stand-alone operators, their queries and SQL."""

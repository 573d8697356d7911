"""DataFrame operators, parameterised by column names, keys and thresholds."""

"""DataFrame operators: byte models and their integer CDFs, context windows, comparisons, attention, coverage."""

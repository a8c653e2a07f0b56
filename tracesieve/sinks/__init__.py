"""Writing runs, rounds and fitted models as tables."""

"""Multi-operator jobs: signals, features, grids, training sets."""

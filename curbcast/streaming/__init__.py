"""Live location and heading streams: stateless steps, folds, state processors."""

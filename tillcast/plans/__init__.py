"""Plans: the operators composed into the feature, exploration, profile, model and
inventory jobs, and the registry of named queries with their SQL oracles."""

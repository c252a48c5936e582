"""User-level composites: features, cohorts, model, skills, search."""

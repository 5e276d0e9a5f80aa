"""Driver-side plans: evidence, registries, coercion, pipelines, generated SQL."""

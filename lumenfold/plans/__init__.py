"""Image plans: stages as Spark ML estimators and transformers, their grammar, and running them."""

"""Operations of a training-data pipeline, one module each; their queries and SQL are in ``queries``."""

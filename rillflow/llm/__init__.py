"""Operations of a training-data pipeline: deduplication, quality, tokens, mixing, sharding."""

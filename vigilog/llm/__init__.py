"""Operations of a training-data pipeline: filters, deduplication, search, scoring, tokens."""

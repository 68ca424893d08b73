"""Operations of a training-data pipeline: text filters, duplicates, tokens, scores, shards and search."""

"""Operations of a training-data pipeline: filters, duplicates, packing, shards, token files."""

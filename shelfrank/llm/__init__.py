"""Operations of a training-data pipeline, each a DataFrame-to-DataFrame function."""

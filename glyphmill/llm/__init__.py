"""Operations of a training-data pipeline. Nothing else in glyphmill imports this package."""

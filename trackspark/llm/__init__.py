"""Operations of a training-data pipeline over documents. Nothing else in the library imports this subpackage."""

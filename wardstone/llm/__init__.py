"""Operations of a training-data pipeline; `queries.py` registers one query per operation."""

"""Training-data pipeline operators (ten numbered operators, see README)."""

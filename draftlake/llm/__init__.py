"""Operators of a training-data pipeline: rules, personal data, secrets, licences, duplicates,
mixing, chat formatting, packing and a quality classifier."""

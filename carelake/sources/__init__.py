from carelake.sources.adapter import Tables  # noqa: F401

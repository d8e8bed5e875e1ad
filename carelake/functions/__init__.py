from carelake.functions import compat, masking  # noqa: F401

"""Part of the analytics library."""

from . import registry, catalogue  # noqa: F401, I001  (catalogue adds to what registry holds)

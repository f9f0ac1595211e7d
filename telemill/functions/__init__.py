"""Scalar helpers with pinned semantics."""
from telemill.functions.semantics import *  # noqa: F401,F403

"""Scalar functions: ``text`` and ``geometry`` are Column expressions, ``pure`` the same rules for use inside page-level functions."""

"""Operators for preparing training text at corpus scale. Nothing outside this subpackage imports it."""

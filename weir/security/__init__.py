"""Checks before anything is read or sent: paths, file modes, pins, TLS."""


class Insecure(ValueError):
    """A refusal to start."""

"""DataFrame-level operators built on :mod:`textguard.functions`."""

"""feedlens: social-post analytics as lazy Spark DataFrame operators.

Every public operator takes a DataFrame (usually with the ``posts`` schema,
see :mod:`feedlens.schema`) and returns a DataFrame; nothing is collected to
the driver except one-row statistics and report writes.
"""

__version__ = "0.1.0"

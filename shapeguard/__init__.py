"""shapeguard: guarded profiling and cleaning of string tables on PySpark."""

__version__ = "0.1.0"

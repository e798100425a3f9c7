"""worldloom: analytics over checkpoints of persistent object worlds, on Spark DataFrames.

Tables go in, DataFrames come out.  ``sources`` reads them, ``functions`` holds column
expressions, ``operators`` the relational and graph operators, ``plans`` the registered
queries with their SQL twins, ``streaming`` the incremental forms.
"""

__version__ = "0.1.0"

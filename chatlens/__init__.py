"""chatlens: conversation-corpus analytics expressed as Spark DataFrame plans.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from native
Spark expressions, so Catalyst plans it and the work stays on the executors.
"""

__version__ = "0.1.0"

"""Column-expression helpers (all JVM-side, codegen friendly)."""

from chatlens.functions.expr import (idiv, mean_round, pct, share_of_window,
                                     top_n_per_group)
from chatlens.functions.text import (flatten_messages, java_pattern,
                                     re2_pattern, topic_patterns)

__all__ = ["idiv", "mean_round", "pct", "share_of_window", "top_n_per_group",
           "flatten_messages", "java_pattern", "re2_pattern", "topic_patterns"]

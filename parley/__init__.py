"""parley: voice-conversation analytics on Spark.

Ordered event streams of many sessions (agent events, chat messages, model
response chunks, speeches, audio frames and vectors) are turned into turn-taking,
playout, text, audio and telemetry results with DataFrame / SQL operators.
"""

import sys as _sys

from parley.params import DEFAULT, Params

try:  # Python steps (applyInPandas & co.) ship their code by value: no install on executors.
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["Params", "DEFAULT"]

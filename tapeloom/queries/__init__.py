from tapeloom.queries import bars, io, models, news, streams, warehouse  # noqa: F401
from tapeloom.queries.registry import ORACLE, QUERIES  # noqa: F401

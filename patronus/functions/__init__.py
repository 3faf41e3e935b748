from patronus.functions.numeric import rnd, money, exact_mean, safe_ratio, pct  # noqa: F401
from patronus.functions.keyed import keyed_uniform, keyed_normal  # noqa: F401

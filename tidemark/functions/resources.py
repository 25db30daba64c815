"""How many nodes and cores a sort of a given size needs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Memory for each byte of input: all references, or one of them.
ALL_FACTOR, ONE_FACTOR = 1.5, 2.5


def estimate(size_gb: Column, kind: Column, node_gb: float, node_cores: int, all_factor: float = ALL_FACTOR, one_factor: float = ONE_FACTOR) -> dict[str, Column]:
    """Columns of the estimate; ``kind`` is ``all`` or ``one``."""
    memory = size_gb * F.when(kind == "all", all_factor).otherwise(one_factor)
    nodes = F.ceil(memory / node_gb)
    cores = F.ceil(memory / (node_gb / node_cores))
    power = F.pow(F.lit(2.0), F.floor(F.log2(cores.cast("double")))).cast("bigint")
    return {
        "mem_gb": memory,
        "nodes": nodes.cast("bigint"),
        "cores": cores.cast("bigint"),
        "pow2_cores": power,
        "mem_per_core": F.round(memory / power, 1),
        "cores_per_node": F.ceil(power / nodes).cast("bigint"),
    }

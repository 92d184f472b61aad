"""One operator over many graphs, with a report row for each."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.graphs import Graph
from graphloom.sources.tables import append_report


def run_all(graphs: dict[str, Graph], operator: Callable[[Graph], DataFrame], path: str, skip: int = 0, most: int | None = None) -> None:
    """Run ``operator`` on the graphs from few edges to many and append ``dataset, v, e, time_ms`` to the report at ``path``.

    ``skip`` and ``most`` choose a slice of that order.
    """
    sizes = sorted((g.edges.count(), name) for name, g in graphs.items())
    for e, name in sizes[skip : None if most is None else skip + most]:
        graph = graphs[name]
        v = graph.vertices.count()
        began = time.perf_counter()
        operator(graph).write.format("noop").mode("overwrite").save()
        took = round((time.perf_counter() - began) * 1000)
        append_report(graph.edges.sparkSession.createDataFrame([(name, v, e, took)], "dataset string, v bigint, e bigint, time_ms bigint"), path)

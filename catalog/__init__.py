"""The registered queries, each with the SQL that gives the same rows."""

import sys

from pyspark import cloudpickle

from catalog import batches, cells, evaluation, prompts, scoring, selection, sources, streams, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = [sources, selection, prompts, evaluation, tables, cells, batches, streams, scoring]


def queries():
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}

"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator has a
general function (its own parameters and real outputs) and a thin query in
``queries.py`` that applies it to a whole table.
"""

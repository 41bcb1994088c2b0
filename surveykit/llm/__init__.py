"""Operators of a training-data pipeline, with their registered queries and SQL twins.

``registry.load_all()`` fills ``registry.QUERIES`` and ``registry.SQL``. Nothing else in the library imports this
package, so it can be taken away.
"""

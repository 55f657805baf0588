"""Operators for training-data pipelines: packing, WARC archives, quality
rules, language-model scoring, URL filters, language identification,
near-duplicates, sharding, decontamination and secret scans.

Nothing else in the library imports this subpackage.

Common rules of all operators: the input frame may have any further columns;
only the named ones are read and the output has exactly the documented
columns, so clashing names cannot arise. Row order is not part of a result.
"""

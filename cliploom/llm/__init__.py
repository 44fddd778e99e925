"""Training-data operators over the `documents`, `pages`, `benchmark` and `labels` tables.

Nothing outside this package imports it.  Each module holds one operator with a general interface;
`queries` derives the registered result columns from them and `oracles` holds the matching SQL.
"""

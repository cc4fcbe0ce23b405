"""skyecho: analog reconstruction of climate series as Spark plans.

Everything takes and returns DataFrames; the plans live in ``operators`` and
``functions``, readers and writers in ``sources``, the registered queries in
``plans``, the continuous versions in ``streaming``.
"""

"""Household cash-flow analytics as Spark DataFrame operators.

Layers:

* ``sources``    files to typed bronze frames, and the Parquet table writers
* ``functions``  ``Column -> Column`` helpers shared by the operators
* ``operators``  ``DataFrame(s) -> DataFrame`` operators, all lazy
* ``plans``      bronze -> silver -> gold refreshes built from the above
"""

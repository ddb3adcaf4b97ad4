"""siftkit: document screening and evaluation on Spark DataFrames.

Every operator is either a ``Column`` builder (``siftkit.functions``) that
works inside one row, or a ``DataFrame -> DataFrame`` function
(``siftkit.operators``, ``siftkit.plans``).  Nothing collects to the driver.
"""

__version__ = "0.1.0"

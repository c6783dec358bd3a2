"""farpoint: anomaly analytics on Spark DataFrames.

Rows travel as DataFrames that keep an ``id`` and a ``label`` next to an
``ARRAY<DOUBLE>`` feature column.  Fitted models are small tables (dictionaries,
column statistics, components, centres); rows never pass through the driver.
"""

__version__ = "0.1.0"

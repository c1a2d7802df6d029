"""A PySpark engine for labelled multichannel time series."""

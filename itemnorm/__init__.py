"""itemnorm: cleaning and analysing catalogs of purchase-line descriptions with PySpark."""

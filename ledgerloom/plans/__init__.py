"""Plans over tables: derived views, the driver's query catalog and the whole reconciliation."""

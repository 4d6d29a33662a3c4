"""CDC, medallion, versioned-table, data-quality and trading-analytics operators for Spark."""

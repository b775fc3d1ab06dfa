"""Analytics over large collections of linked notes and documents on Spark."""

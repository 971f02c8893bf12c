"""Analytics over large collections of long, outlined, tagged documents, on Spark."""

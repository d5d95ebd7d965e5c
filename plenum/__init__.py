"""Analytics over meetings, documents and conversations, written as Spark DataFrame operators."""

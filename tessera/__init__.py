"""Analytics over large (date, symbol) panels as plain DataFrame functions on Spark."""

"""Analytics over code graphs, change history and text, as DataFrame operators."""

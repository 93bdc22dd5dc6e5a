"""Analytics over symbols, edges, events and text, as DataFrame functions."""

"""Tables and what is derived from them."""

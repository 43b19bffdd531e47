"""Tables and the views on them."""

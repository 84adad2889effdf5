"""Flow definitions and the expressions in them."""

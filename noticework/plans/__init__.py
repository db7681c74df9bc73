"""The notice pipeline itself: product tables and the reports built on them."""

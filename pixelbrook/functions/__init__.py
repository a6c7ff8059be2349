"""Column functions: container bytes, pixels, codec arithmetic and options. All stay in Catalyst expressions."""

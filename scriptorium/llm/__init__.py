"""Training-data operators: ten methods and their queries; nothing else in the library imports them."""

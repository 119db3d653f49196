"""Column functions: text, phones, money and order rules."""

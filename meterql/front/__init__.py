"""Reading and printing of statements; pure Python."""

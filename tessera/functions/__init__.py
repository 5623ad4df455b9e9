"""Column expressions and small grammars."""

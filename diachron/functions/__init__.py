"""Column expressions: tokenizer, phrase forms, colours, closed-form scores."""

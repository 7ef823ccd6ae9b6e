"""Column functions: tokens, templates, tools, numbers and vector graphics."""

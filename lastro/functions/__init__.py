"""Column expressions and name rules; nothing here touches data on its own."""

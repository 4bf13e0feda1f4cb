"""The analysis' questions, their fixture bindings and their SQL oracle."""

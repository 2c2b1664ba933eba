"""Document-structure analytics as DataFrame operators."""

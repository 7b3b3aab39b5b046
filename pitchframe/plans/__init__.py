"""End-to-end DataFrame plans composed from the operators."""

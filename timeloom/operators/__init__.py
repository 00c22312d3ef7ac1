"""Table operators over canonical events."""

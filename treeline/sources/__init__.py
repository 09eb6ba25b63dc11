"""Tables and the trees that they hold."""

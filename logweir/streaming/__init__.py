"""Live tails, windowed streams and stream-fed views."""

"""gridpulse.streaming"""

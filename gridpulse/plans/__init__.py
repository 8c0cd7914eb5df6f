"""gridpulse.plans"""
